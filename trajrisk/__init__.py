"""Traffic-risk analytics on vehicle trajectories as Spark jobs."""
