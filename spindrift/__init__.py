"""spindrift: a PySpark-native engine for cleaning, modelling and searching experimental records."""
