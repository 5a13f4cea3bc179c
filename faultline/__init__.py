"""faultline: log forensics and incident analytics expressed as Spark plans."""
