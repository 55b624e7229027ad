"""gymlake.sources"""
