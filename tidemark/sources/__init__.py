"""Reading and writing: snapshots, inventories, archives and the live source."""
