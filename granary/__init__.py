"""granary: Spark jobs that build, search, clean and evaluate a text corpus."""
