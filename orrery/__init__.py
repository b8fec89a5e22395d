"""T-SQL on Spark over databases of Parquet tables, and operators for text corpora in orrery.llm."""
