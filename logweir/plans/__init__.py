"""Query languages: parsing, normal form, and compilation to Spark columns."""
