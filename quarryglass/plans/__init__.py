"""Physical helpers: durable cuts, bounded broadcasts, skew-safe joins."""
