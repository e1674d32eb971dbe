"""basalt: a PySpark-native analytics engine.

Relational operators, warehouse builders and layered pipelines as DataFrame plans.
"""
