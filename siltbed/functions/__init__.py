"""Column functions: distances, uniforms that an SQL engine can replay, CSV fields."""
