"""Source-code intelligence on Spark: graph, diff, ranking, findings and accuracy operators as DataFrame functions."""
