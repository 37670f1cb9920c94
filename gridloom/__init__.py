"""gridloom: gridded spatial analytics expressed as Spark DataFrame plans."""
