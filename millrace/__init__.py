"""millrace: news and sports-event analytics as DataFrame -> DataFrame functions on Spark."""
