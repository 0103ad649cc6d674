"""Feature sets, stacking and rating assignment for an ordinal target, as Spark jobs."""
