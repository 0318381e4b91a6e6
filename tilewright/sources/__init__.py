"""tilewright.sources"""
