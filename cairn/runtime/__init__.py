"""Running stages: configuration, plans, reuse of published results, selection of runs, validation and a command line."""
