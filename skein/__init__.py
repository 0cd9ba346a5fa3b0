"""skein: analytics of metrics, logs, traces and search as Spark DataFrame programs."""
