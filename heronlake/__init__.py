"""heronlake: knowledge retrieval and document analytics as Spark dataflows."""
