"""An ordered key-value analytics engine on Spark: changelog, immutable sorted runs, one resolved view."""
