"""Evidence-trace analytics on Spark: find, validate, attribute and report traces of wallet data and leaked credentials."""
