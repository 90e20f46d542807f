"""Plans: routing, move and relocate plans, workflow manifests."""
