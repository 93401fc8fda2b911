"""Column functions: geodesy, 3x3 matrices, polygons and text."""
