"""Period-over-period site analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
