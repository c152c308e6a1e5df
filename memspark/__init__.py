"""memspark: Spark jobs over agent-memory tables."""
