"""A PySpark engine for curating conversational corpora and analysing model outputs."""
