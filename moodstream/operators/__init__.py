"""DataFrame-to-DataFrame jobs: ingest, labels, trends, topics, posts, voting, learning."""
