"""Decision rules, whole analyses and end-to-end runs composed from the operators."""
