"""Column helpers: text rules, JSON narrowing and order-preserving numbering."""
