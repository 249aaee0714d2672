"""Column expressions: times, texts, geometry and drawing sizes."""
