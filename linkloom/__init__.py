"""Evidence-backed relationship graphs, reconciliation and corpus preparation as Spark jobs."""
