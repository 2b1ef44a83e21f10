"""Monthly regional panel analytics and forecasting as Spark DataFrame operators."""
