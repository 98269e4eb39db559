"""Plans that combine the operators."""
