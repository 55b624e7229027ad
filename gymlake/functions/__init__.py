"""gymlake.functions"""
