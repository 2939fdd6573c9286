"""Binary pages: kernels, the node tree, its reader and writer, and the planner that chooses trees."""
