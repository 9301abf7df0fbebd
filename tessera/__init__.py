"""Web-intelligence analytics on Spark: extraction, scoring, link graph and reporting as DataFrame plans."""
