"""State over time: sessions, caches, rate limits, leases; each as a stream and as a batch fold."""
