"""attrweave: discovers which attributes of many independent sources mean the same, on Spark."""
