"""Typed synthetic tables, measurable data faults and their audits, as Spark jobs."""
