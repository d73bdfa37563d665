"""adsight: marketing decision analytics expressed as Spark DataFrame operators."""
