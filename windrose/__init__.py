"""windrose: gridded screening, event verification and corpus preparation as Spark DataFrame jobs."""
