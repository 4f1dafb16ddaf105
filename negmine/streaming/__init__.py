"""Row-local operators on a stream of corpus records."""
