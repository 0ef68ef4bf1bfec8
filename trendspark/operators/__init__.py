"""DataFrame jobs rebuilt from the reference's per-item loops."""
