"""DataFrame operators: chains, templates, filters, routing, retrieval."""
