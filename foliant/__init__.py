"""Document analytics on Spark: text and markup into offset-addressed rows, and questions over them."""
