"""gradeloom: a Spark-native engine for grading model outputs and preparing the data around them."""
