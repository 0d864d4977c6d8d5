"""Formula dialect, aggregates and calendar algebra."""
