"""Particle-trajectory clustering on Spark: voxels, lattice seeds, components, density methods, metrics."""
