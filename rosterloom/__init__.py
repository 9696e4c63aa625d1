"""rosterloom: contact-registry analytics expressed as Spark DataFrame jobs."""
