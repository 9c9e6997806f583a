"""Column builders: text, dates, numbers; and Arrow UDFs for what Spark has no expression for."""
