"""Operators over tables of nodes, quads and documents."""
