"""quern: a Spark-native SQL analytics engine with a MySQL-flavoured query surface."""
