"""weirflow: dataflow algebra, profiling analytics and plan analysis as plain Spark DataFrame jobs."""
