"""A PySpark-native engine for collections of administrative documents."""
