"""vecloom: a Spark-native engine for collections of dense vectors."""
