"""Query registry: named keys -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""
