"""loomcell: a PySpark-native engine for sparse, dynamically growing schemas.

Data are entities, a registry of fields and only the cells that exist; every
question is a Spark DataFrame plan over those three tables.
"""
