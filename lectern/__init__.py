"""Reading-structure analytics of extracted document text on PySpark."""
