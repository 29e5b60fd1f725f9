"""Plan-shape helpers: blocked prefix sums, exact quantiles, bounded
broadcasts and lineage cuts that keep jobs distributed at scale."""
