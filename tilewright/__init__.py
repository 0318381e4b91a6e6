"""tilewright: spatial and corpus analytics expressed as Spark plans."""
