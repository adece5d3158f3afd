"""netloom: a PySpark-native engine for detection, geometry, netlist and corpus data."""
