"""DataFrame operators for serving traces, telemetry, evaluation verdicts and code facts."""
