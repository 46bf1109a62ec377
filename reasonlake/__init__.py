"""Analytics over agent-session traces and training corpora, as ordinary Spark jobs."""
