"""Multi-job plans (fit, report, experiment) and the registered query catalogue."""
