"""privlake: privacy analytics over corpora of pages, documents, form fields and outbound payloads, as Spark DataFrame operators."""
