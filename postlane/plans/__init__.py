"""Reports over stored state, a whole run, and the registered queries."""
