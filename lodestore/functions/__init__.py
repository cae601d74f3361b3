"""Identity rules, limits and scalar functions of the catalogue."""
