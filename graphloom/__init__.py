"""graphloom: typed knowledge graphs, search and recommendation as set-based Spark jobs."""
