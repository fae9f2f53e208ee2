"""captionforge: subtitle analytics expressed as Spark DataFrame plans."""
