"""subgrade: reconcile measured point clouds with registered lines, on Spark."""
