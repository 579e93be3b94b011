"""Programs and profiling analytics composed of the operators."""
