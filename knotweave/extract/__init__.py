"""Language plugins: text to nodes and edges."""
