"""lexloom: lexical ETL, matching, auditing and text repair as PySpark DataFrame operators."""
