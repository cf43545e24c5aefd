"""Product-catalog analytics on Spark: pages in, versioned catalog tables out."""
