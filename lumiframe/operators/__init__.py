"""Relational operators over views, points, matches, blocks and voxels."""
