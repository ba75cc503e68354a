"""Mining typed knowledge graphs for multi-hop questions, as Spark jobs."""
