"""litspark: literature topic analytics as PySpark DataFrame operators.

sources/    paper CSV reader, stage store, sinks, synthetic corpus
functions/  column expressions: text regexes, vector math, output formats
operators/  clean, text, embed, cluster (Ward), topics, council, review,
            themes, taxonomy, compare, report
plans/      pipeline composition, registered queries and their DuckDB oracle
streaming/  incremental ingestion of new documents into the sentence stage
"""
