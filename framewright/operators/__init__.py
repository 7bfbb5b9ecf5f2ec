"""DataFrame operators, grouped by the step of the pipeline they belong to."""
