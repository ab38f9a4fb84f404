"""factloom.plans."""
