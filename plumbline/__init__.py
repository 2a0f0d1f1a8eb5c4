"""plumbline: Spark-first measurement-network adjustment and corpus analytics."""
