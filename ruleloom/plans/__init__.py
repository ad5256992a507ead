"""Search plans: configuration, lattice, scores and discovery."""
