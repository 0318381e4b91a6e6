"""tilewright.functions"""
