"""tarn: a Spark-native store of versioned entities with declared hourly rollups."""
