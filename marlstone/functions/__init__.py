"""Array and scalar rules that operators share."""
