"""foldloom: a PySpark-native engine for controlled perturbation-benchmark studies."""
